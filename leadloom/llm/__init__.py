"""Large-scale text and entity operators; nothing outside this folder imports them."""
