"""Single-object writes: validated, optimistically concurrent, audited."""
