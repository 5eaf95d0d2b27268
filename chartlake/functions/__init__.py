"""chartlake.functions"""
