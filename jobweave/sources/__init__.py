"""Where job tables come from."""
