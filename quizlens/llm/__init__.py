"""Operations for preparing training text, each with a query over the generic tables."""
