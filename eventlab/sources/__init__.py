"""Sources and sinks (A1-A4): ``files.read_table``, ``read_delimited``,
``read_quarantined``, ``write_table``, ``stage``."""
