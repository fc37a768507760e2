"""siltline.operators"""
