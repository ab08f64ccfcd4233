"""Operators for preparing training corpora.  Nothing else in keyfold imports this subpackage."""
