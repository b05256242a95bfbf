"""Operators for building training corpora.  Nothing outside this subpackage imports it;
the driver's entry point adds its queries only when it can be imported."""
