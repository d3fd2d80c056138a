"""sheetwise: a DataFrame-first engine that compares drawing documents, and a training-data toolkit in ``sheetwise.llm``."""
