"""Operators over long tables (series_id, pos, time, value); every one works on all series at once."""
