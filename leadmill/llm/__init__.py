"""Training-data operators: ten operators over the `documents` table, and their queries.

Nothing outside this subpackage imports it (``__spark_entry__.py`` adds its queries when it is there).
"""
