"""Training-data operators over text, web pages, vectors and token files.

Nothing else in the library imports this subpackage.
"""
