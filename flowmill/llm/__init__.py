"""Operators for large-scale training-data pipelines over documents tables.

Nothing outside this subpackage imports it.  Conventions shared by all operators:

* an operator takes a DataFrame and the names of its id and text columns, reads only those columns
  and returns its own columns, so extra columns with clashing names never matter;
* a null text counts as the empty text and a null id is carried through as null, unless a docstring
  says otherwise; repeated rows are rows of their own; an empty table gives an empty result;
* texts are processed whole, in slices of bounded bytes, so one very long text is the largest unit;
* tables that a later step reads twice are written to the shared folder of ``spark.checkpoint.dir``.
"""
