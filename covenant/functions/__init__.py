"""Functions as column builders."""
