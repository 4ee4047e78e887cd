"""Corpus operators for training-data pipelines (registered in ``seatplan.llm.registry``).

Nothing else in the library imports this subpackage.
"""
