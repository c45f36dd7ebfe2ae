"""One registered query per operator, with its SQL twin where SQL can express it."""
