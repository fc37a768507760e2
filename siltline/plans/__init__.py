"""siltline.plans"""
