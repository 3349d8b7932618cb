"""Readers for export folders, observation payloads and pages, and the writers."""
