"""Readers and writers of manifests, predictions, sweeps, logs, captions and checksums."""
