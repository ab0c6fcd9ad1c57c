"""Tables of a vault and their readers."""
