"""Part of linkloom."""
