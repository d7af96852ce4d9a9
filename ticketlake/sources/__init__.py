"""Readers, writers and table builders."""
