"""Operations for preparing large text and vector corpora. Nothing outside this package imports it."""
