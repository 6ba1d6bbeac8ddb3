"""Readers and writers: archives, stored chapters, events, outbox, snapshots."""
