"""Readers and writers: register extracts, uploads, hierarchy JSON, exports, snapshots."""
