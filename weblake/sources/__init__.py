"""Readers: raw log files, the masked layer, object notifications."""
