"""Training-data operators.  Nothing outside this subpackage imports it.

Conventions shared by every operator here
-----------------------------------------
* Only the columns an operator needs are read; extra columns, whatever their
  names, are ignored (pipeline stages carry the documents columns through).
* A null text counts as the empty text; a null id is an id like any other.
* An empty table gives an empty result with the usual schema.
* Intermediate tables are written under ``spark.checkpoint.dir`` (read from the
  session), so a lost executor costs a re-read, not a re-run, and no lineage is
  kept on executor-local storage.
"""
