"""folioscan.sources"""
