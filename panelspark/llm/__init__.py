"""Training-data operators over large text and vector tables. Nothing outside this folder imports it."""
