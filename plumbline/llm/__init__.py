"""Training-data operators for text corpora, one module each.

Nothing outside this folder imports it; ``plumbline.llm.queries`` registers
the queries.
"""
