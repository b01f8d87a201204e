"""The same operators over unbounded logs."""
