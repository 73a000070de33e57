"""Scored top-k joins, index builders, mining and metrics as DataFrame plans."""
