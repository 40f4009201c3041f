"""The interactive event machine over streams, with a batch twin that gives the same rows."""
