"""Readers and writers for order tables, reference tables, timetables and snapshots."""
