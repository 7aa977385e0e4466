"""The panel's questions, one function per result set."""
