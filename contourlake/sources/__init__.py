"""Readers and writers of manifests, keys, answers, audio, result tables and kits."""
