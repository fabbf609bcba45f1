"""Training-data operators: ten corpus operators, their queries and their SQL.

Nothing outside this subpackage imports it; ``registry`` lists the queries.
"""
