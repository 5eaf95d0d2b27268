"""chartlake.sources"""
