"""Training-data operators: quality rules, tokenisation, packing, extraction,
URL reputation, weak-label classification, language-model scoring,
near- and exact de-duplication, secret scanning.

One module per operator; each registers its query in
:mod:`evtrail.llm.registry`.
"""
