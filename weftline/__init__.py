"""Weftline: a DataFrame library for crawled pages, social feeds, images and text corpora."""
