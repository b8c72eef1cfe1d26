"""quarrystone subpackage."""
