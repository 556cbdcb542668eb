"""Sources: tables of files, and the handlers that their extensions choose."""
