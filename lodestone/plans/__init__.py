"""Configuration, the three modes, the command line and the registered queries."""
