"""Readers and writers: JSON frames, alert feed, frame store, message tables."""
