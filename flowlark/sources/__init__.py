"""Reading and writing message logs."""
