"""quillspark: DataFrame-to-DataFrame operators for large document collections.

Every operator takes DataFrames and returns a DataFrame; some first write a
table they read several times (``session.cut``) or fit a small model, so that
building a query may run jobs.  What comes to the driver is bounded and does
not grow with the tables: counts, model parameters and lists whose bound is
stated where they are made.  ``quillspark.llm`` holds the
operators for training data and is optional: no other module imports it.
"""
