"""Training-data operators: extraction, search, packing, filters, dedup, shards and archives.

Nothing outside this subpackage imports it; ``queries.py`` lists what it registers.
"""
