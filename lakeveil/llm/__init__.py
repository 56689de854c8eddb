"""Training-data operators: ten corpus jobs and their registered queries (see queries.py)."""
