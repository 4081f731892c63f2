"""folioscan.plans"""
