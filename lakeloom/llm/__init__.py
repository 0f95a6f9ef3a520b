"""Operators for preparing training text at corpus scale.

Nothing else in the library imports this subpackage.  Every operator takes a
DataFrame plus the names of its id and text columns, projects just those two
first (so extra columns, whatever their names, never reach it), and returns a
new DataFrame.  Intermediate tables that have to outlive a plan are written to
the shared folder of ``spark.checkpoint.dir`` (see :mod:`lakeloom.llm.common`).
"""
