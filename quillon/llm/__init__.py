"""Training-data operators: ten corpus operators and the queries that apply them.

Nothing outside this folder imports it; the registry adds its queries only when it can be imported.
"""
