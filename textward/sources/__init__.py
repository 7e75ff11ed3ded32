"""textward.sources"""
