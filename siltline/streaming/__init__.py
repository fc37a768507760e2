"""siltline.streaming"""
