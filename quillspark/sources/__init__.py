"""Readers and writers: text files in several encodings, cards, packs, NDJSON and partitioned tables."""
