"""Operators of a training-data pipeline, each a Spark job over ``documents``.

Nothing outside this subpackage imports it.  ``jobsift.llm.queries`` registers
one query per operator; ``corpus_pipeline`` chains five of them.
"""
