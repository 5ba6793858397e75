"""Training-data operators: Spark jobs over documents, pages, embeddings and conversations.

Nothing outside this subpackage imports it.  Each module holds one operator with
its own general interface; ``queries`` holds the thin registered queries.
"""
