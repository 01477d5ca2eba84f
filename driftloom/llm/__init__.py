"""Training-data operators over tables of texts. Nothing else in driftloom imports this subpackage."""
