"""folioscan.functions"""
