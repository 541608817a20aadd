"""Training-data operators over a table of documents; nothing else here imports them."""
