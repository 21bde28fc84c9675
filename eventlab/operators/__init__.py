"""DataFrame operators: ``filters`` (C, D7), ``events`` (E, G6), ``joins``
(D4-D6), ``summary`` (F, H1, H2), ``reshape`` (G), ``design`` (H3),
``linear`` (H4, H5, H9, H10, H13), ``means`` (H8), ``mixed`` (H6, H7, H11)."""
