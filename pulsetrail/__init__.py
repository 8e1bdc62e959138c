"""Event-ledger and attribution analytics as Spark DataFrame operators.

Every operator is a plain function ``op(df, ..., params) -> DataFrame`` that
composes with ``df.transform``.  Nothing here starts an action unless its
docstring says so (only the iterative near-duplicate prune does).
"""
