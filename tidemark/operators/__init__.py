"""Bars, indicators, detectors and lookups as lazy DataFrame transforms.

Every function takes and returns DataFrames and runs no job.  Bars are rows
(series_id, bar_idx, epoch, open, high, low, close, volume); bar_idx counts a
series' bars from 0 and is the key that all detectors join on.
"""
