"""Plan-building helpers: scratch tables, fixpoint loops, input loading."""
