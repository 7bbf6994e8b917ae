"""Where relations come from and go to: source trees, policy files, registers, reports."""
