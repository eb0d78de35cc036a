"""Scans of series, labels, raw corpora, category maps and period lists."""
