"""Readers and writers: corpora, specs, event logs, stores, gated sinks."""
