"""folioscan.streaming"""
