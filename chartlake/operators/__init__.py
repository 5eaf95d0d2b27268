"""chartlake.operators"""
