"""Operations for preparing training data at scale, one module per operator.

Nothing outside this subpackage imports it; the registered queries are in
``lanewise.llm.registry``.
"""
