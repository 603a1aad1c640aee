"""Training-data operators over documents, pages, conversations and benchmark items.

Nothing else in the library imports this subpackage.
"""
