"""replyforge: customer-support message analytics as PySpark DataFrame jobs.

Every public function takes and returns DataFrames (or Columns); nothing holds
a global session.  ``functions`` are column expressions, ``operators`` are
DataFrame transformations, ``sources`` read and write tables, ``plans`` wires
operators into whole jobs, and ``streaming`` runs the routing job on a stream.
"""
