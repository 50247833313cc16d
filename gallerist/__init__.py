"""Open-set identification and evaluation over embeddings, as Spark plans.

Sub-packages: ``functions`` (column expressions), ``sources`` (readers and
writers), ``operators`` (relational building blocks), ``plans`` (composite
queries and their SQL twins), ``streaming`` (stateful stream operators) and
``llm`` (training-data operators; nothing else imports it).
"""

__version__ = "0.1.0"
