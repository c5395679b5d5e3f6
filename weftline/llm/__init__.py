"""Training-data operators over document tables.

Nothing else in the library imports this subpackage; ``queries.py`` holds its
registered queries and their SQL.
"""
