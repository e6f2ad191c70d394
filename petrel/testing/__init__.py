"""Writers of test inputs.  Fixtures only: the engine reads these formats, it does not write them."""
