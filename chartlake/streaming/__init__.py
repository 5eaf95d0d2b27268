"""chartlake.streaming"""
