"""Training-data operators: each module holds one operator and its registered query."""

#: Modules whose registry ``R`` holds queries.
MODULES = ("near_dup", "decontaminate", "secrets", "chat", "warc", "hamming", "pieces", "token_counts", "lm", "quality", "bpe", "align", "lexical")
