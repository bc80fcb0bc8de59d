"""Operators of a training-data pipeline, each built by one named method.

``token_shards`` (1), ``quality_rules`` (2), ``url_rules`` (3),
``parity_join`` (4), ``toxicity`` (5), ``fuzzy_lines`` (6), ``pfair_mix`` (7),
``bpe_automaton`` (8), ``spotsigs`` (9), ``secret_scan`` (10); their registered
queries and oracle SQL are in ``catalog``. Nothing else in the library imports
this subpackage.
"""
