"""Tables read and written by the operators."""
