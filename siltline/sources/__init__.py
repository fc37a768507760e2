"""siltline.sources"""
