"""Readers of the file formats that models are built from, and writers of the stores."""
