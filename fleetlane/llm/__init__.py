"""Training-data pipeline operators: one module per operator, plus the
registered queries (``queries``).  Nothing else in the library imports
this subpackage."""
