"""Reports: compositions of the operators that answer one question each."""
