"""siltline.functions"""
